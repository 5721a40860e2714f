"""Small configurations of our own for the tests and the bench: two indented ones, braces, config/end, flat, XML."""

IOS = """!
version 15.2
service timestamps log datetime
hostname {name}
!
aaa new-model
aaa accounting exec default start-stop group tacacs+
username ops privilege 15 secret 9 $9$abcdefgh
username old password 7 0822455D0A16
enable secret 5 $1$mERr$hx5r
ip ssh version 2
ip http server
no ip http secure-server
spanning-tree mode pvst
!
interface GigabitEthernet0/1
 description uplink to internet
 ip address 198.51.100.{n} 255.255.255.0
 speed 100
 unknown-thing 7
!
interface Vlan900
 description management
 ip address 10.9.0.{n}/24
 ip access-group MGMT in
 no shutdown
!
ip access-list extended MGMT
 permit ip any any
 20 deny tcp 10.0.0.0 0.0.0.255 any eq 22 log
 permit tcp host 10.1.1.1 any range 80 443
!
logging host 10.0.0.5
snmp-server community public RO
ntp server 10.0.0.1
banner motd ^
 interface fake
 hostname fake
^
line con 0
 exec-timeout 5 0
line vty 0 4
 exec-timeout 30 0
 transport input telnet ssh
line vty 5 15
 exec-timeout 10 0
 transport input ssh
end
"""
EOS = """hostname leaf
transceiver qsfp default-mode 4x10G
no aaa root
username ops privilege 15 role network-admin secret sha512 $6$same$hash
aaa authentication login default group tacacs+
tacacs-server host 10.0.0.20
ntp authenticate
ntp server 10.0.0.1 key 1
management ssh
   idle-timeout 10
management telnet
   shutdown
management api http-commands
   no shutdown
interface Ethernet1
   ip address 10.0.0.7/24
snmp-server community secretword RO
"""
JUNOS = """version 21.4R3;
system {
    host-name edge;
    login {
        idle-timeout 10;
        user ops {
            class super-user;
            authentication {
                encrypted-password "$6$same$hash";
            }
        }
    }
    services {
        ssh {
            protocol-version v2;
        }
        web-management {
            https {
                port 443;
            }
        }
    }
    syslog {
        host 10.0.0.5 {
            any info;
        }
    }
    ntp {
        server 10.0.0.1;
    }
}
interfaces {
    ge-0/0/0 {
        description wan;
        unit 0 {
            family inet {
                address 203.0.113.9/30;
            }
        }
    }
    ge-0/0/1 {
        unit 0 {
            family inet {
                filter {
                    input CORE;
                }
                address 10.0.0.1/24;
            }
        }
        disable;
    }
}
snmp {
    community public {
        authorization read-only;
    }
}
"""
FORTIOS = """#config-version=FGT60E-7.2.5-FW
config system global
    set hostname "fw"
    set admintimeout 30
    set admin-telnet enable
    set admin-ssh-v1 disable
end
config system interface
    edit "port1"
        set ip 10.0.0.9 255.255.255.0
        set alias "mgmt"
        set allowaccess ping https http
    next
    edit "port2"
        set status down
        set mystery yes
    next
end
config system ntp
    set ntpsync enable
    config ntpserver
        edit 1
            set server "10.0.0.1"
        next
    end
end
config system admin
    edit "admin"
        set password ENC abcdef
    next
end
"""
ROUTEROS = """# 2024-01-01 by RouterOS 7.14
# serial number = ABC123
/system identity set name=branch
/interface ethernet set [ find default-name=ether1 ] comment="wan side" default-name=ether1
/ip address add address=198.51.100.2/24 interface=ether1
/ip service set telnet disabled=no
/ip service set www disabled=yes
/snmp community set [ find default=yes ] name=public
/system ntp client servers add address=10.0.0.1
/user add name=ops group=full
/tool something add x=1
"""
PANOS = """<?xml version="1.0"?>
<config version="10.1.0" urldb="paloaltonetworks">
  <devices>
    <entry name="localhost.localdomain">
      <deviceconfig>
        <system>
          <hostname>pa</hostname>
          <ip-address>10.0.0.10</ip-address>
          <netmask>255.255.255.0</netmask>
          <service>
            <disable-telnet>yes</disable-telnet>
            <disable-http>no</disable-http>
          </service>
          <ntp-servers>
            <primary-ntp-server>
              <ntp-server-address>10.0.0.1</ntp-server-address>
              <authentication-type>
                <none/>
              </authentication-type>
            </primary-ntp-server>
          </ntp-servers>
        </system>
      </deviceconfig>
      <network>
        <interface>
          <ethernet>
            <entry name="ethernet1/1">
              <layer3>
                <ip>
                  <entry name="203.0.113.1/30"/>
                </ip>
              </layer3>
              <mystery>1</mystery>
            </entry>
          </ethernet>
        </interface>
      </network>
    </entry>
  </devices>
</config>
"""
ALL = {"ios": IOS.format(name="core", n=3), "eos": EOS, "junos": JUNOS, "fortios": FORTIOS, "routeros": ROUTEROS, "panos": PANOS}


def files(spark, texts: dict[str, str], role: str = "config"):
    return spark.createDataFrame([(k, "running", role, v) for k, v in texts.items()], "device_id string, file string, role string, text string")
