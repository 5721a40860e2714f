"""The thirteen rules that come with the engine.

Ids, severities, assertions, probes, frameworks and commands are fixed values; titles and reasons are
ours.
"""

from __future__ import annotations

#: Fixed: id, severity, assertion, probe, frameworks besides CIS-v8.
RULES = [
    ("1.1.1", "critical", "mgmt.telnet_enabled == false", "telnet_reachable", "NIST-SP800-53:AC-17 STIG-NET0700 ISO27001:A.8.20 ISO27001:A.8.24"),
    ("1.1.2", "high", "mgmt.ssh.enabled == true and mgmt.ssh.version == 2", None, "NIST-SP800-53:AC-17 STIG-NET1638 ISO27001:A.8.20 ISO27001:A.8.24"),
    ("1.2.4", "medium", "mgmt.idle_timeout_min <= 10", "no_session_timeout", "NIST-SP800-53:AC-11 STIG-NET0993 ISO27001:A.8.5"),
    ("1.3.1", "high", "mgmt.http_enabled == false", "http_mgmt_exposed", "NIST-SP800-53:SC-8 STIG-NET1660 ISO27001:A.8.20 ISO27001:A.8.24"),
    ("1.4.1", "critical", "defined(mgmt.mgmt_acl)", "acl_bypass", "NIST-SP800-53:AC-3 STIG-NET1637 ISO27001:A.5.15 ISO27001:A.8.20"),
    ("2.1.1", "high", "snmp.version == 3", "default_snmp_community", "NIST-SP800-53:IA-3 STIG-NET0894 ISO27001:A.8.20 ISO27001:A.8.24"),
    ("2.1.2", "critical", "not any(snmp.communities, community in [default])", "default_snmp_community", "NIST-SP800-53:IA-5 STIG-NET0893 ISO27001:A.5.17 ISO27001:A.8.9"),
    ("3.1.1", "medium", "defined(logging.servers) and not empty(logging.servers)", None, "NIST-SP800-53:AU-4 STIG-NET1021 ISO27001:A.8.15"),
    ("4.1.1", "medium", "ntp.authenticated == true", "unauthenticated_ntp", "NIST-SP800-53:AU-8 STIG-NET0813 ISO27001:A.8.17"),
    ("5.1.1", "high", "aaa.enabled == true and not empty(aaa.servers)", None, "NIST-SP800-53:IA-2 STIG-NET1623 ISO27001:A.5.15 ISO27001:A.8.5"),
    ("5.2.1", "high", "all(aaa.local_users, user.hash in [scrypt, pbkdf2, sha512])", None, "NIST-SP800-53:IA-5(1) STIG-NET1636 ISO27001:A.5.17 ISO27001:A.8.24"),
    ("5.3.1", "high", "not any(mgmt.ssh.kex, algo in [diffie-hellman-group1-sha1, diffie-hellman-group-exchange-sha1])", "weak_ssh_kex", "NIST-SP800-53:SC-13 STIG-NET1639 ISO27001:A.8.24"),
    ("6.1.1", "medium", "all(interfaces, iface.shutdown == true or iface.is_mgmt == true or defined(iface.acl_in))", "acl_bypass", "NIST-SP800-53:SC-7 STIG-NET0740 ISO27001:A.8.20 ISO27001:A.8.22"),
]

#: Title and reason of each rule.
WORDS = {
    "1.1.1": ("Telnet is off", "Whoever can read the wire reads the password of a Telnet session, and no log shows it."),
    "1.1.2": ("SSH is on, version 2 only", "Version 1 can be tampered with, and where it may be negotiated the other side chooses it."),
    "1.2.4": ("Idle sessions end within ten minutes", "A session left open belongs to whoever finds it."),
    "1.3.1": ("Plain HTTP management is off", "Cookies and passwords of a plain HTTP session can be read on the way."),
    "1.4.1": ("Management access is restricted", "Without a list every host that can route to the device may try its management services."),
    "2.1.1": ("SNMP is version 3", "Earlier versions send the community in clear text, and it opens the configuration."),
    "2.1.2": ("No default community", "Well-known communities are tried first by everybody."),
    "3.1.1": ("Logs leave the device", "Logs that stay on a device go with it."),
    "4.1.1": ("Time is authenticated", "Whoever can move a clock makes logs of several devices useless."),
    "5.1.1": ("Accounts are central", "Access that is only local can't be taken back in one place."),
    "5.2.1": ("Local secrets are well hashed", "A copy of a configuration is a copy of weakly hashed passwords."),
    "5.3.1": ("No weak key exchange", "Small groups can be broken by those who have the means."),
    "6.1.1": ("Interfaces filter what comes in", "An interface without a filter trusts whatever is plugged in."),
}

#: Fixed: commands that mend a failure, by rule and target.
COMMANDS = {
    "1.1.1": {
        "panos": ["configure", "set deviceconfig system service disable-ssh no", "set deviceconfig system service disable-telnet yes", "commit"],
        "cisco_ios": ["configure terminal", "ip ssh version 2", "line vty 0 15", " transport input ssh", "no ip telnet server", "end", "write memory"],
        "juniper": ["set system services ssh protocol-version v2", "commit", "delete system services telnet", "commit"],
        "fortios": ["config system global", " set admin-ssh-v1 disable", " set admin-telnet disable", "end"],
        "routeros": ["/ip service set ssh disabled=no", "/ip service set telnet disabled=yes"],
        "vyos": ["set service ssh", "commit", "delete service telnet", "commit", "save"],
    },
    "1.1.2": {
        "panos": ["configure", "set deviceconfig system service disable-ssh no", "commit"],
        "cisco_ios": ["configure terminal", "ip ssh version 2", "line vty 0 15", " transport input ssh", "end", "write memory"],
        "juniper": ["set system services ssh protocol-version v2", "commit"],
        "fortios": ["config system global", " set admin-ssh-v1 disable", "end"],
        "vyos": ["set service ssh", "commit", "save"],
    },
    "1.2.4": {
        "panos": ["configure", "set deviceconfig setting management idle-timeout 10", "commit"],
        "cisco_ios": ["configure terminal", "line vty 0 15", " exec-timeout 10 0", "end", "write memory"],
        "juniper": ["set system login idle-timeout 10", "commit"],
        "fortios": ["config system global", " set admintimeout 10", "end"],
        "vyos": ["set system login timeout 600", "commit", "save"],
    },
    "1.3.1": {
        "vyos": ["set service https listen-address 0.0.0.0", "delete service http", "commit", "save"],
        "panos": ["configure", "set deviceconfig system service disable-https no", "set deviceconfig system service disable-http yes", "commit"],
        "cisco_ios": ["configure terminal", "no ip http server", "ip http secure-server", "end", "write memory"],
        "juniper": ["delete system services web-management http", "set system services web-management https system-generated-certificate", "commit"],
        "fortios": ["config system global", " set admin-sport 443", " set admin-https-redirect enable", "end"],
        "routeros": ["/ip service set www disabled=yes", "/ip service set www-ssl disabled=no"],
    },
    "1.4.1": {
        "vyos": ["set firewall name MGMT-IN rule 10 action accept", "set firewall name MGMT-IN rule 10 source address 10.0.0.0/24", "set firewall name MGMT-IN default-action drop", "commit", "save"],
        "panos": ["configure", "set deviceconfig system permitted-ip 10.0.0.0/24", "commit"],
        "cisco_ios": ["configure terminal", "ip access-list standard MGMT_HOSTS", " permit 10.0.0.0 0.0.0.255", " deny any log", "line vty 0 15", " access-class MGMT_HOSTS in", "end", "write memory"],
        "juniper": ["set firewall family inet filter MGMT_HOSTS term allow from source-address 10.0.0.0/24", "set system services ssh connection-limit 10", "commit"],
        "fortios": ["config system interface", " edit mgmt", "  set trusthost1 10.0.0.0 255.255.255.0", " next", "end"],
    },
    "2.1.1": {
        "vyos": ["set service snmp v3 user monitor auth plaintext-key AUTHPASS", "set service snmp v3 user monitor privacy plaintext-key PRIVPASS", "delete service snmp community public", "commit", "save"],
        "panos": ["configure", "set deviceconfig system snmp-setting access-setting version v3 views monitor view all oid 1.3.6.1 option include", "set deviceconfig system snmp-setting access-setting version v3 users monitor view monitor authpwd AUTHPASS privpwd PRIVPASS", "delete deviceconfig system snmp-setting access-setting version v2c", "commit"],
        "cisco_ios": ["configure terminal", "no snmp-server community public", "no snmp-server community private", "snmp-server group SECURE v3 priv", "snmp-server user monitor SECURE v3 auth sha AUTHPASS priv aes 128 PRIVPASS", "end", "write memory"],
        "juniper": ["delete snmp community public", "set snmp v3 usm local-engine user monitor authentication-sha", "commit"],
        "fortios": ["config system snmp sysinfo", " set status enable", "end", "config system snmp user", " edit monitor", "  set security-level auth-priv", " next", "end"],
    },
    "2.1.2": {
        "vyos": ["delete service snmp community public", "delete service snmp community private", "commit", "save"],
        "panos": ["configure", "delete deviceconfig system snmp-setting access-setting version v2c", "commit"],
        "cisco_ios": ["configure terminal", "no snmp-server community public", "no snmp-server community private", "end", "write memory"],
        "routeros": ["/snmp community remove [find name=public]"],
    },
    "3.1.1": {
        "vyos": ["set system syslog host 10.0.0.5 facility all level info", "commit", "save"],
        "panos": ["configure", "set shared log-settings syslog central-syslog server siem-01 server 10.0.0.5 transport UDP port 514", "commit"],
        "cisco_ios": ["configure terminal", "logging host 10.0.0.5", "logging trap informational", "service timestamps log datetime msec localtime show-timezone", "end", "write memory"],
        "juniper": ["set system syslog host 10.0.0.5 any info", "commit"],
        "fortios": ["config log syslogd setting", " set status enable", " set server 10.0.0.5", "end"],
    },
    "4.1.1": {
        "vyos": ["set system ntp key 1 type sha1 value NTPKEY", "set system ntp server 10.0.0.1 key 1", "commit", "save"],
        "panos": ["configure", "set deviceconfig system ntp-servers primary-ntp-server authentication-type symmetric-key key-id 1 algorithm sha1 authentication-key NTPKEY", "commit"],
        "cisco_ios": ["configure terminal", "ntp authenticate", "ntp authentication-key 1 md5 NTPKEY", "ntp trusted-key 1", "ntp server 10.0.0.1 key 1", "end", "write memory"],
        "juniper": ["set system ntp authentication-key 1 type md5 value NTPKEY", "set system ntp trusted-key 1", "set system ntp server 10.0.0.1 key 1", "commit"],
    },
    "5.1.1": {
        "vyos": ["set system login radius server 10.0.0.9 secret RADKEY", "set system login radius server 10.0.0.9 port 1812", "commit", "save"],
        "panos": ["configure", "set shared server-profile tacplus TACACS server tac1 address 10.0.0.9 secret TACKEY", "set shared authentication-profile ADMIN method tacplus server-profile TACACS", "set deviceconfig system authentication-profile ADMIN", "commit"],
        "cisco_ios": ["configure terminal", "aaa new-model", "tacacs server AAA1", " address ipv4 10.0.0.20", "aaa authentication login default group tacacs+ local", "aaa accounting exec default start-stop group tacacs+", "end", "write memory"],
        "juniper": ["set system tacplus-server 10.0.0.20", "set system authentication-order [ tacplus password ]", "commit"],
    },
    "5.2.1": {
        "vyos": ["set system login user admin authentication plaintext-password NEWPASSWORD", "commit", "save"],
        "panos": ["configure", "set mgt-config users admin password", "commit"],
        "cisco_ios": ["configure terminal", "username admin algorithm-type scrypt secret NEWPASSWORD", "no username admin password", "end", "write memory"],
        "juniper": ["set system login user admin authentication encrypted-password NEWHASH", "commit"],
    },
    "5.3.1": {
        "panos": ["configure", "set deviceconfig system ssh profiles mgmt-profiles STRONG kex ecdh-sha2-nistp256", "set deviceconfig system ssh mgmt-config server-profile STRONG", "commit"],
        "cisco_ios": ["configure terminal", "ip ssh dh min size 2048", "end", "write memory"],
        "juniper": ["set system services ssh key-exchange group-exchange-sha2", "commit"],
        "vyos": ["set service ssh key-exchange diffie-hellman-group-exchange-sha256", "commit", "save"],
    },
    "6.1.1": {
        "vyos": ["set interfaces ethernet eth1 firewall in name USER_IN", "commit", "save"],
        "panos": ["configure", "set zone untrust network layer3 ethernet1/1", "commit"],
        "cisco_ios": ["configure terminal", "interface range GigabitEthernet0/1 - 48", " ip access-group USER_IN in", "end", "write memory"],
        "fortios": ["config firewall policy", " edit 0", "  set srcintf user", "  set action accept", " next", "end"],
    },
}
